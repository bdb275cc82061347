"""Column functions: text, digests, identities, urls."""
