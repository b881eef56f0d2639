"""Operators for preparing language-model training data (near duplicates, filters, chat
formatting, packing, mixing, binary output). Nothing else in the library imports this
subpackage; it may use the library's general helpers."""
