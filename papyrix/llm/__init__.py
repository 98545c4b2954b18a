"""Training-data operators: self-contained, nothing else in the library imports this subpackage."""
