"""Sources and sinks: schemas, configuration, files, generated and derived tables."""
