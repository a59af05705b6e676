"""The stateless row rules over streams."""
