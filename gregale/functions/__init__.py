"""Column functions: the text kernel and small scalar helpers."""
