"""Training-data operators over document corpora.

Nothing outside this package imports it; removing the folder leaves the
rest of the library working.
"""
