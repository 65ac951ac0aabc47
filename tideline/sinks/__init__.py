"""Writers: partitioned lake, catalog snapshots, insight documents, JDBC."""
