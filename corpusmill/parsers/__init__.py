"""Lexers, validators and chunkers of the four supported source languages."""
