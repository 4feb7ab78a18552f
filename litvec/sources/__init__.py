"""Readers and writers: id lists, document files, passage and embedding tables, collections."""
