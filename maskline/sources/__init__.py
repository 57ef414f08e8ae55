"""Where lines come from and where results go."""
