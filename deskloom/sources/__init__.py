"""Readers and writers: archive, memberships, versioned tables, exports."""
