"""From rule text to one projection."""
