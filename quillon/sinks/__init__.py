"""Where results go: CSV, XLSX, JSON bundles, Markdown and a page."""
