"""Readers and writers of batches, configuration sheets and the historical store."""
