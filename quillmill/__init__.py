"""quillmill: web-clip and text corpora as Spark jobs."""
