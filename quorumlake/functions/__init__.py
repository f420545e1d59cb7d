"""Part of the library; see the README for its contents."""
