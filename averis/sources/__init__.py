"""Part of averis."""
