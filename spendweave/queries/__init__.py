"""Named queries over the shared tables, one per operator or report."""
