"""End-to-end plans that chain the operators (clean layer, feature matrix)."""
