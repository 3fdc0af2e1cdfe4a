"""Where evidence graphs come from and go to."""
