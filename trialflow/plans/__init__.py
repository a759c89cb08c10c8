"""The operators composed: raw feeds to stored tables to the experiment's result."""
