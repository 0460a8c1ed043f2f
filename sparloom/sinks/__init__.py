"""Writers of tables, documents, queues and workbooks."""
