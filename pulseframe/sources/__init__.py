"""Sources and sinks: fixtures, activity lines, messages, files, tables."""
