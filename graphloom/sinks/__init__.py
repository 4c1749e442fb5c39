"""Writers of the text layouts of the analytics."""
