"""Packets of signals as streams with carried state."""
