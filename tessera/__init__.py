"""Media-container analytics on Spark: chunked containers, catalogs, timelines, signals and codecs as DataFrame plans."""
