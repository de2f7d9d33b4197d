"""airgrid: air-corridor analytics on Spark."""
