"""Sources and sinks: link exports, pages, HTML output."""
