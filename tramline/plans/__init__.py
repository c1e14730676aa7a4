"""Running rules over a feed."""
