"""Sources: file trees, change logs, JSON contracts and tables."""
