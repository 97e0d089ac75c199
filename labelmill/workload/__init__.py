"""Every registered query: name -> (Spark query, equivalent SQL or None)."""

from labelmill.workload import curation, display, model, text

ALL = {**curation.QUERIES, **text.QUERIES, **model.QUERIES, **display.QUERIES}
