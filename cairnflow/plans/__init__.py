"""Session set-up and derived views."""
