"""Reading and writing: lake tables, change and execution-event feeds, saved results."""
