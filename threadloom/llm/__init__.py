"""Operators for building language-model training sets; nothing outside imports them."""
