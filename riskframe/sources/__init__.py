"""Readers, inventories, samples and table maintenance."""
