"""quillspark: review and recommendation analytics written as Spark jobs."""
