"""Reports and end-to-end runs composed from operators."""
