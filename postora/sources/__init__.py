"""Where documents come from and are stored."""
