"""Independent SQL for the registered queries, used only to check results."""
