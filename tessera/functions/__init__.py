"""Column functions and constants: levels, stencils, prediction coefficients, curve keys, fluxes, quadrature."""
