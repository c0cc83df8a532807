"""Sources: folders of files to tables of (file_path, file_name, content, metadata)."""
