"""Operators for training data: copies hidden by formatting, match groups, token ids, leaked tests, text quality."""
