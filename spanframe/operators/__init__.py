"""DataFrame operators over documents and spans."""
