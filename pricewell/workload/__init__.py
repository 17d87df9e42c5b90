"""The operators run over the shared test tables, each beside SQL for the same answer."""
