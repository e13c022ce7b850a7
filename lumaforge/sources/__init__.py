"""Readers and writers for image files, tag blocks, recipes and exports."""
