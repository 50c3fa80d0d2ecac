"""textloom: content extraction and text analytics as Spark DataFrame transformations."""
