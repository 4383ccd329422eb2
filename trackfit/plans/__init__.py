"""Plans made of operators: the detector cascade, searches by estimated size, reports."""
