"""Sources: bank tables and files, detector rows, mail, evaluations; sinks with versions."""
