"""Campaign pipelines composed from the sources and operators."""
