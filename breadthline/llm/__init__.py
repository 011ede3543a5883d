"""Training-data operators over tables of documents. Nothing outside imports this subpackage."""
