"""Where change rows come from."""
