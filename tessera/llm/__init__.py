"""Training-data operators for document tables; nothing else in the library imports this subpackage."""
