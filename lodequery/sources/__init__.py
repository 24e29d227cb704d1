"""Readers, versioned stores and schemas."""
