"""Session set-up, presets and registered queries."""
