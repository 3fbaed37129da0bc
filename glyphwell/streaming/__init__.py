"""The same conversions over streams of documents."""
