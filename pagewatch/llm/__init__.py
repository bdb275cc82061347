"""Training-data operators: ten jobs on documents, pages, vectors and conversations.

Nothing else in the library imports this subpackage.
"""
