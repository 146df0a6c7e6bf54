"""Column to Column functions; nothing here runs a job or leaves the JVM."""
