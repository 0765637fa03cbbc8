"""pixelloom: palette and pixel analytics over large image collections, expressed as Spark DataFrame operators."""
