"""Readers and writers of FASTQ, SAM and BAM."""
