"""Operators over whole tables: collections, corpora, clusters, graphs, tries."""
