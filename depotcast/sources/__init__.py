"""Readers, writers and the mapping of the supplied tables onto the logical inputs."""
