"""Record linkage, overlay resolution and corpus analytics as DataFrame plans."""
