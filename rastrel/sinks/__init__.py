"""Images and reports, written through any file system that Arrow opens."""
