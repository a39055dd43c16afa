"""Where logs and runs come from and go to."""
