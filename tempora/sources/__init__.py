"""Sources and sinks at the edge of the engine: file scans, artifacts, channel folders, download requests."""
