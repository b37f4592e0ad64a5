"""Sources: configuration, capabilities, routing and scans."""
