"""Sound files, packet containers and their listing."""
