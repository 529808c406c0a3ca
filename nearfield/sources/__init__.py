"""Where collections come from and go to: snapshots, codecs, text, seeds."""
