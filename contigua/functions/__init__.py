"""Part of the contigua engine."""
