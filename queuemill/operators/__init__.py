"""DataFrame operators over the request table."""
