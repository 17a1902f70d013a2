"""Training-data operators over large text tables. Nothing else in the library imports this subpackage."""
