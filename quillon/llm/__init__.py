"""Training-data operators: filters, de-duplication, tokenisation and packing."""
