"""Tables, files and the conversion log."""
