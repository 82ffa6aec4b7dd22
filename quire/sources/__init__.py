"""Where records come from and go to: files, decoded pages, feeds and the record store."""
