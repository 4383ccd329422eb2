"""Sources and sinks: signals from tables, texts and files; stored encodings and byte containers."""
