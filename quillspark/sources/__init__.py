"""Sources: files and their texts, archives, stored indexes."""
