"""Asset catalog and lineage graph on Spark: catalogues, graph queries and text jobs as DataFrame plans."""
