"""Plan helpers shared by the operators: ordered chunks, binned range joins, folders."""
