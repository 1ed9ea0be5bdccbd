"""DataFrame -> DataFrame operators: ingest, links, materials, board, extras."""
