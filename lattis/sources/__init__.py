"""Sources and sinks: file trees, XML, text, the corpus on disk."""
