"""Small token budget fixtures."""
